"""Hand cases and invariants of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.functions import labels as L
from flowmill.operators import clean, explain, imbalance, metrics, models, neighbours, prepare, profile, ranking, ranks, robust, significance
from flowmill.operators import sampling as S
from flowmill.sources import bundles, caches, captures

NAN, INF = float("nan"), float("inf")


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_label_functions(spark):
    raw = ["Web Attack \x96 XSS", " BENIGN", "DoS  Hulk", None, "Brute Force -Web", "dos newkind", "ＦＴＰ-Patator"]
    assert column(spark, raw, L.normalize_label)[:4] == ["web attack xss", "benign", "dos hulk", ""]
    assert column(spark, raw, L.combined_family) == ["Web Attack", "BENIGN", "DoS", "Other", "Web Attack", "Other", "Other"]
    assert column(spark, raw, lambda c: L.map_to_multiclass(L.normalize_label(c)))[5] == "DoS"
    df = spark.createDataFrame([(x,) for x in raw], "v string")
    assert {r.v: r.k for r in L.normalize_labels(df, "v", "k").collect()}["ＦＴＰ-Patator"] == "ftp-patator"
    assert column(spark, ["infiltration ", "DDOS attack-hoic", " odd "], L.alias_label) == ["Infilteration", "DDOS attack-HOIC", "odd"]


def test_clean_chain_drops_columns_and_rows(spark):
    df = spark.createDataFrame([("1", "80", "BENIGN", "2"), ("x", "80", "DDoS", "3"), ("Infinity", "80", "DDoS", "4"), ("4", "80", "DDoS", "5"), ("Label", "80", "Label", "1")], "` Fwd Pkts/s` string, ` Destination Port` string, ` Label` string, `Protocol` string")
    out = clean.clean_flows(df, "Label", ["Fwd Packets/s"])
    assert out.columns == ["Fwd Packets/s", "Destination Port", "label"] and sorted(map(tuple, out.collect())) == [(1.0, "80", "BENIGN"), (4.0, "80", "DDoS")]


def test_validation(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        clean.validate_schema(df, ["a", "c"], "a")
    assert sorted(map(tuple, clean.validate_schema(df, ["a", "c"], "a", strict=False).collect())) == [("b", "extra"), ("c", "missing")]
    with pytest.raises(ValueError):
        clean.assert_absent(df, "a")
    t = spark.createDataFrame([("14/02/2018 08:31:01",), ("02/31/2018 00:00:00",)], "t string").withColumn("ts", clean.parse_timestamp(F.col("t")))
    with pytest.raises(ValueError, match="02/31/2018"):
        clean.require_timestamps(t, "t", "ts")


def test_captures_keep_row_numbers(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_bytes(b"a,Label\n" + b"".join(f"{i},Web \x96 {k}\n".encode("latin-1") for i in range(50 * k + 3)))
    df = captures.row_positions(captures.scan_captures(spark, str(tmp_path)))
    rows = df.collect()
    assert len(rows) == 159 and all(int(r.a) == r.row_index for r in rows) and rows[0].Label.startswith("Web \x96")


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(1.0, None, "b", 2), (1.0, None, "a", 9), (0.0, 1.0, "a", 1), (-0.0, 1.0, "c", 0)], "x double, y double, f string, i int")
    assert sorted(map(str, clean.dedup_keep_first(df, ["x", "y"], ["f", "i"], ["f", "i"]).select("f", "i").collect())) == ["Row(f='a', i=1)", "Row(f='a', i=9)"]


def frame(spark, counts):
    rows = [(i * 1000 + k, c, k) for i, (c, n) in enumerate(counts.items()) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, label string, ord int")


def test_chronological_split(spark):
    df = frame(spark, {"A": 90, "B": 2, "C": 1, "D": 11}).withColumn("source", F.lit("s"))
    for s in (S.chronological_split(df, ["source", "label"], "ord", "row_id"), S.chronological_split(df, ["source", "label"], "ord", "row_id", range_rows=5), S.chronological_split(df.withColumn("source", F.lit(None).cast("string")), ["source", "label"], "ord", "row_id", buckets=7, range_rows=5)):
        assert {r.label: (r.n_train, r.n_test) for r in S.split_manifest(s, "label").collect()} == {"A": (62, 28), "B": (1, 1), "C": (1, 0), "D": (7, 4)}
        assert s.where("label = 'A' and side = 'train'").agg(F.max("ord")).first()[0] == 61
    assert [tuple(r) for r in S.require_test_rows(s, "label", 3).collect()] == [("B", 1)]


def test_nested_samples(spark):
    df = frame(spark, {"big": 900, "mid": 90, "rare": 6})
    ids = {}
    for n in (100, 300, 600):
        s = S.nested_sample(df, "label", "row_id", n, 5)
        ids[n] = {r.row_id for r in s.collect()}
        assert len(ids[n]) == n and s.where("label = 'rare'").count() >= 5
    assert ids[100] < ids[300] < ids[600]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert {r.row_id for r in S.nested_sample(df.repartition(7), "label", "row_id", 300, 5).collect()} == ids[300]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(Exception, match="can't be met"):
        S.nested_sample(df, "label", "row_id", 10, 5).collect()


def test_folds_and_shuffles(spark):
    df = frame(spark, {"A": 50, "B": 3, "C": 2})
    clipped = S.stratified_folds(df, "label", "row_id", 5)
    assert {r.fold for r in clipped.collect()} == {0, 1}
    pinned = S.stratified_folds(df, "label", "row_id", 3, pin_rare=True)
    assert {r.label for r in pinned.where("fold is null").collect()} == {"C"}
    mixed = S.shuffle_labels(df, "label", "row_id")
    assert {r.label: r["count"] for r in mixed.groupBy("label").count().collect()} == {"A": 50, "B": 3, "C": 2}
    assert mixed.join(df.withColumnRenamed("label", "was"), "row_id").where("label <> was").count() > 0


def predictions(spark, cells):
    return spark.createDataFrame([(0, t, p) for (t, p), n in cells.items() for _ in range(n)], "model int, y_true int, y_pred int")


def test_metrics_of_a_small_matrix(spark):
    cm = metrics.confusion_matrix(predictions(spark, {(0, 0): 95, (0, 1): 3, (0, 2): 2, (1, 0): 4, (1, 1): 6, (2, 0): 1, (2, 2): 3}), [0, 1, 2])
    e = metrics.extended_metrics(cm, 0, 5).first()
    f1 = [2 * 95 / 200, 2 * 6 / 19, 2 * 3 / 9]
    assert e.f1_macro == pytest.approx(sum(f1) / 3) and e.f1_macro_reportable == pytest.approx((f1[0] + f1[1]) / 2)
    assert (e.binary_fpr, e.missed, e.caught) == (pytest.approx(0.05), 5, 9)
    c, s, t, p = 104, 114, [100, 10, 4], [100, 9, 5]
    assert e.mcc == pytest.approx((c * s - sum(a * b for a, b in zip(t, p))) / math.sqrt((s * s - sum(x * x for x in p)) * (s * s - sum(x * x for x in t))))
    one_sided = metrics.binary_view(metrics.confusion_matrix(predictions(spark, {(0, 0): 5}), [0, 1]), 0).first()
    assert one_sided.binary_recall is None and one_sided.binary_fpr == 0.0


def calibration(spark, y, p, cap):
    df = spark.createDataFrame([(0, t, s) for t, s in zip(y, p)], "model int, y_true int, score double")
    return metrics.calibrate_threshold(df, 1, cap).collect()


def test_threshold_calibration(spark):
    r = calibration(spark, [1, 1, 1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.4, 0.3, 0.7, 0.2, 0.1, 0.05], 0.25)[0]
    assert (r.threshold, r.recall, r.fpr, r.fp, r.fn) == (0.3, 1.0, 0.25, 1, 0)
    assert calibration(spark, [1, 1, 0, 0, 0, 0], [0.8, 0.7, 0.99, 0.98, 0.2, 0.1], 0.0) == []
    probs = spark.createDataFrame([([0.5, 0.2, 0.3],), ([0.1, 0.2, 0.7],), ([0.3, 0.3, 0.2],)], "p array<double>")
    assert [r[0] for r in probs.select(metrics.threshold_decision(F.col("p"), 2, 0.3)).collect()] == [2, 2, 0]


def test_thresholds_are_required(spark):
    df = spark.createDataFrame([(0, t, s) for t, s in zip([1, 1, 0, 0, 0, 0], [0.8, 0.7, 0.99, 0.98, 0.2, 0.1])], "model int, y_true int, score double")
    with pytest.raises(ValueError, match="satisfies max FPR"):
        metrics.require_thresholds(metrics.calibrate_threshold(df, 1, 0.0), df, 0.0)
    assert metrics.require_thresholds(metrics.calibrate_threshold(df, 1, 0.5), df, 0.5).count() == 1


def test_caches_notice_changed_inputs(spark, tmp_path):
    inputs, path = str(tmp_path / "in"), str(tmp_path / "cache")
    half = lambda df: df.where("id % 2 = 0")
    assert caches.is_stale(spark, path, inputs) if spark.range(10).write.parquet(inputs) is None else False
    assert [caches.load_or_build(spark, path, inputs, half)[1] for _ in range(2)] == [True, False]
    spark.range(4).write.mode("append").parquet(inputs)
    df, built = caches.load_or_build(spark, path, inputs, half, n_rows=7)
    assert built and df.count() == 7
    with pytest.raises(ValueError, match="expected 9"):
        caches.load_or_build(spark, path, inputs, half, n_rows=9)


def test_robustness_report_checks_its_inputs(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, y string")
    with pytest.raises(ValueError, match="test lacks"):
        robust.robustness_report(df, df.drop("x"), ["x"], "y", None, None)
    with pytest.raises(ValueError, match="no rows"):
        robust.robustness_report(df, df.limit(0), ["x"], "y", None, None)


def test_rankings(spark):
    rows = [("rf", 0.88, 0.95, 0.9, 0.99, 0.005, 0.4, 80.0, 100.0), ("xgb", 0.87, 0.96, 0.85, 0.99, 0.004, 0.2, 40.0, 15.0), ("mlp", 0.6, 0.9, 0.95, 0.9, 0.2, 0.1, 5.0, 1.0), ("lr", 0.5, 0.8, 0.6, 0.7, None, 0.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "model string, f1_macro double, f1_weighted double, recall_macro double, binary_recall double, binary_fpr double, min_per_class_recall double, p95_ms double, size_mb double")
    policy = ranking.POLICY
    got = {r.ranking: (r.model, r.status) for r in ranking.policy_rankings(df, policy).collect()}
    assert got == {"overall": ("rf", "policy_pass"), "security": ("rf", "policy_pass"), "deployment": ("xgb", "policy_pass")}
    strict = {"s": {"maximize": "recall_macro", "tie": "binary_recall", "constraints": [("binary_fpr", "<=", 0.0)]}}
    assert ranking.policy_rankings(df, strict).first()[1:3] == ("mlp", "conditional_no_model_meets_constraints")
    assert {(r.model, r.failed) for r in ranking.policy_exclusions(df, policy).where("ranking = 'security'").collect()} == {("mlp", "binary_fpr"), ("lr", "binary_fpr")}
    assert ranking.champion(df, "binary_fpr", 0.001).first()[:2] == ("xgb", "conditional_no_model_meets_fpr")


def test_robustness_cases(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "x int, Label string")
    assert [tuple(r) for r in robust.label_conflicts(df, ["x"], "Label").collect()] == [(1, 2, "A,B")]
    assert robust.label_shift_tv(df, spark.createDataFrame([("A",), ("A",)], "Label string"), "Label").first()[0] == pytest.approx(1 / 3)
    p = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, x double")
    assert [round(r.x, 9) for r in robust.perturb(p, ["x"], 0.1, "i", {"x": (0, 2.05)}).orderBy("i").collect()] == [1.1, 1.8]
    base = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    cand = spark.createDataFrame([(2.0, 2.0), (100.0, NAN)], "x double, y double")
    assert [r.ood for r in robust.ood_flags(cand, robust.iqr_profile(base, ["x", "y"]), ["x", "y"]).orderBy("x").collect()] == [False, True]


def test_significance(spark):
    counts = spark.createDataFrame([("a", 10, 2), ("b", 0, 0), ("c", 5000, 1)], "rival string, only_leader long, only_rival long")
    p = {r.rival: r.p for r in significance.binomial_p(counts).collect()}
    assert p["a"] == pytest.approx(2 * sum(math.comb(12, k) for k in range(3)) / 2**12) and p["b"] == 1.0 and 0 <= p["c"] < 1e-100
    paired = spark.createDataFrame([(i, i % 3, i % 3 if i % 5 else 0, i % 3 if i % 2 else 1) for i in range(300)], "row_id long, y_true int, p0 int, p1 int")
    for r in significance.bootstrap_f1(paired, ["p0", "p1"], 200).collect():
        assert r.ci_low <= r.f1 <= r.ci_high and r.ci_high - r.ci_low < 0.2


def test_bootstrap_of_a_rare_class_and_of_differences(spark):
    """A resample that holds no row of the rare class averages over the classes it has, as the point estimate does."""
    rows = [(i, 0, 0, 0) for i in range(199)] + [(199, 1, 1, 0)]
    paired = spark.createDataFrame(rows, "row_id long, y_true int, p0 int, p1 int")
    got = {r.model: r for r in significance.bootstrap_f1(paired, ["p0", "p1"], 200).collect()}
    assert (got["p0"].f1, got["p0"].ci_low, got["p0"].ci_high) == (1.0, 1.0, 1.0) and got["p1"].ci_high == 1.0
    d = significance.bootstrap_differences(paired, "p0", ["p1"], 200).first()
    assert d.d_f1 == pytest.approx(1 - 199 * 2 / 399 / 2) and d.ci_low == 0.0 and 0.4 < d.ci_high < 0.6
    assert significance.macro_f1(np.array([0, 0, 1]), np.array([0, 2, 1]), np.array([1, 1, 1])) == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_trust_bands(spark):
    rows = [("a", 0.0199), ("b", 0.02), ("c", 0.05), ("d", 0.1), ("e", None)]
    df = spark.createDataFrame(rows, "model string, cv_std double").selectExpr("*", "0.5 as f1_macro", "0.5 as accuracy", "0.4 as baseline")
    assert {r.model: r.stability for r in ranking.trust_verdict(df, 5).collect()} == {"a": "stable", "b": "moderate", "c": "variable", "d": "unstable", "e": None}


def test_regularisation_of_logistic_regression(spark):
    df = spark.range(400).selectExpr("id as row_id", "cast(id % 7 as double) as a", "cast(id % 7 > 3 as int) as y")
    ready = models.assemble(df, ["a"], "y")
    assert models.fit("logistic_regression", ready, 2).stages[-1].getRegParam() == pytest.approx(1 / 400)
    assert models.fit("logistic_regression", ready, 2, C=10.0).stages[-1].getRegParam() == pytest.approx(1 / 4000)


def test_pipeline_learns_from_training_rows_only(spark):
    rows = [(i, float(i % 7), None if i % 9 == 0 else float(i % 5), "odd" if i % 10 == 0 else "plain") for i in range(300)]
    train = spark.createDataFrame(rows, "row_id long, a double, b double, Label string")
    test = spark.createDataFrame([(1000, 1e9, None), (1001, 3.0, 2.0)], "row_id long, a double, b double")
    for how in ("weights", "oversample", "none"):
        model, classes = models.fit_pipeline("logistic_regression", train, ["a", "b"], "Label", "row_id", imbalance=how, target="odd", ratio=0.5)
        assert classes == ["odd", "plain"] and model.stages[0].surrogateDF.first().b == 2.0
        got = models.predict(model, classes, test, ["a", "b"], ["row_id"]).collect()
        assert [set(r.asDict()) for r in got] == [{"row_id", "y_pred", "confidence", "p_odd", "p_plain"}] * 2
        assert all(r.y_pred in classes and r.p_odd + r.p_plain == pytest.approx(1) for r in got)
    grown = models.oversampled(train, "Label", "row_id", "odd", 0.5)
    assert {r.Label: r["count"] for r in grown.groupBy("Label").count().collect()} == {"odd": 135, "plain": 270}
    with pytest.raises(ValueError, match="imbalance"):
        models.fit_pipeline("logistic_regression", train, ["a"], "Label", "row_id", imbalance="other")


def test_search_gives_null_for_a_failing_candidate(spark, monkeypatch):
    df = spark.range(120).selectExpr("id as row_id", "cast(id % 7 as double) as a", "cast(id % 7 > 3 as int) as y", "cast(id % 2 as int) as fold")
    ready = models.assemble(df, ["a"], "y").join(df.select("row_id", "fold"), "row_id").cache()
    monkeypatch.setitem(models.SPACES, "logistic_regression", {"C": [1.0], "tol": [1e-3, -1.0]})
    got = {r.params: r.f1_mean for r in models.search("logistic_regression", ready, 2, [0, 1], 2, 5).collect()}
    assert got["[('C', 1.0), ('tol', -1.0)]"] is None and got["[('C', 1.0), ('tol', 0.001)]"] > 0.9


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, None, None)], "a double, b double, c double")
    assert prepare.impute_median(df, df, ["a", "b", "c"]).agg(F.sum("b"), F.sum("c")).first()[:] == (15.0, 0.0)
    assert {r["column"] for r in prepare.constant_columns(df, ["a", "b", "c"]).collect()} == {"b", "c"}
    out = prepare.fit_apply(df, df.drop("a"), ["a", "b", "c"])
    assert out.columns == ["a"] and {round(r.a, 9) for r in out.collect()} == {round((2 - 7 / 3) / math.sqrt(14 / 9), 9)}
    pairs = profile.correlation_pairs(spark.createDataFrame([(float(i), 2.0 * i + (i % 2) * 0.01, 1.0, float(i * 7 % 5)) for i in range(50)], "a double, b double, k double, c double"), ["a", "b", "k", "c"])
    assert prepare.correlation_filter(pairs, ["a", "b", "k", "c"], 0.99) == ["a", "k", "c"]


def test_oversampling(spark):
    df = frame(spark, {"big": 100, "small": 30})
    ranked = S.hash_rank(df, "label", "row_id")
    grown = prepare.random_oversample(ranked, prepare.target_quota(df, "label", "small", 0.7), "label")
    assert {r.label: r["count"] for r in grown.groupBy("label").count().collect()} == {"big": 100, "small": 70}
    assert {r["count"] for r in grown.where("label = 'small'").groupBy("row_id").count().collect()} == {2, 3}


def test_synthetic_rows_lie_between_neighbours(spark):
    pts = spark.createDataFrame([(i, [float(i), 0.0], 1) for i in range(8)] + [(100 + i, [i + 0.4, 0.1], 0) for i in range(4)], "row_id long, x array<double>, y int")
    rows = imbalance.smote(pts, "y", 1, 3, k=2).collect()
    assert len(rows) == 24 and all(abs(r.seed_id - r.neighbour_id) <= 2 and r.seed_id != r.neighbour_id for r in rows)
    assert all(r.x[0] == pytest.approx(r.seed_id + r.gap * (r.neighbour_id - r.seed_id)) for r in rows)
    near = {r.row_id: r.neighbours for r in imbalance.nearest_minority(pts.where("y = 0"), pts, "y", 1, 2).collect()}
    assert near[100] == [0, 1] and near[103] == [3, 4]
    assert {r.row_id for r in imbalance.danger_points(pts, "y", 1, k=2).collect()} <= {0, 1, 2, 3, 4}


def test_neighbours_match_brute_force_across_blocks(spark, monkeypatch):
    """Unit vectors in 64 dimensions, whose neighbours are further off than 1, in many small blocks."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:220] = x[0]
    y = np.arange(240) % 4
    pts = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(240)], "row_id long, x array<double>, y int").cache()
    dist = np.round(((x[:, None] - x[None]) ** 2).sum(2), 12)
    np.fill_diagonal(dist, np.inf)

    def nearest(i, k, among=np.arange(240)):
        return sorted((j for j in among.tolist() if j != i), key=lambda j: (dist[i, j], j))[:k]

    plain = [i for i in range(240) if i and not 200 <= i < 220]  # the others are equal
    votes = {r.row_id: r.votes for r in imbalance.nearest_votes(pts, "y", 3).collect()}
    assert len(votes) == 240 and all(len(v) == 3 for v in votes.values())
    few = [i for i in plain if not {0, *range(200, 220)} & set(nearest(i, 4))]
    assert len(few) > 100 and all(votes[i] == [y[j] for j in nearest(i, 3)] for i in few)
    near = {r.row_id: r.neighbours for r in imbalance.nearest_minority(pts.where("y <> 1"), pts, "y", 1, 5).collect()}
    ones = np.flatnonzero(y == 1)
    few = [i for i in plain if y[i] != 1 and not {*range(200, 220)} & set(nearest(i, 6, ones))]
    assert len(near) == 180 and len(few) > 50 and all(near[i] == nearest(i, 5, ones) for i in few)
    foes = {i: sum(y[j] != 1 for j in nearest(i, 10)) for i in ones.tolist()}
    danger = {r.row_id for r in imbalance.danger_points(pts, "y", 1).collect()}
    few = [i for i in ones.tolist() if not {0, *range(200, 220)} & set(nearest(i, 11))]
    assert few and all((i in danger) == (5 <= foes[i] < 10) for i in few)


def test_shapley_values_add_up(spark):
    rows = spark.createDataFrame([(i, float(i), float(i * i), 1.0) for i in range(6)], "row_id long, a double, b double, c double")
    rule = lambda x: x["a"] * x["b"] + 3 * x["c"]
    phi = explain.sampling_shapley(rows, rows, ["a", "b", "c"], rule, permutations=6)
    total = {r.row_id: r.s for r in phi.groupBy("row_id").agg(F.sum("phi").alias("s")).collect()}
    mean = sum(i**3 + 3 for i in range(6)) / 6
    assert all(total[i] == pytest.approx(i**3 + 3 - mean) for i in range(6))
    assert all(r.phi == pytest.approx(0) for r in phi.where("feature = 'c'").collect())


def test_models_learn_and_elimination_keeps_the_signal(spark):
    df = spark.range(400).selectExpr("id as row_id", "cast(id % 7 as double) as a", "cast(id % 3 as double) as b", "cast(id * 37 % 11 as double) as noise", "cast(id % 7 > 3 as int) as y")
    ready = models.assemble(df, ["a", "b", "noise"], "y").cache()
    for name in ("random_forest", "boosted_trees", "logistic_regression"):
        s = models.score(models.fit(name, ready, 2), ready)
        assert models.macro_f1(s, [0, 1]).first().f1_macro > 0.95
        assert all(sum(r.probability) == pytest.approx(1) for r in s.limit(20).collect())
    assert models.eliminate(df, ["a", "b", "noise"], "y", 2, keep=1) == ["a"]


def test_manifests(spark):
    actual = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 3, "h")], "name string, size long, sha256 string")
    declared = spark.createDataFrame([("a", 1, "h"), ("b", 9, "h"), ("d", 1, "h"), ("../e", 1, "h")], "name string, size long, sha256 string")
    assert {tuple(r) for r in bundles.manifest_diff(actual, declared).collect()} == {("b", "size"), ("c", "undeclared"), ("d", "missing"), ("../e", "path escape")}
    with pytest.raises(ValueError):
        bundles.require_rows(actual, 5)


def test_exact_p_of_small_and_large_splits():
    for n in (0, 1, 2, 7, 40, 300):
        for k in range(n // 2 + 1):
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
            assert significance._two_sided(k, n - k) == pytest.approx(want, rel=1e-12)
    for n in (10**6, 10**8, 10**10):
        assert significance._two_sided(n // 2, n // 2) == 1.0
        # two standard deviations off the middle: close to the normal tail with continuity correction
        off = int(n**0.5)
        z = (2 * off - 1) / n**0.5
        assert significance._two_sided(n // 2 - off, n // 2 + off) == pytest.approx(math.erfc(z / 2**0.5), rel=1e-4)


@pytest.mark.parametrize("n", [0, 1, 2, 500, 40_000])
def test_quantiles_match_sorted_values(spark, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=n)
    b = rng.integers(0, 5, n).astype(float)  # ties
    b[: n // 3] = 2.0
    c = np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n) * 1e9)
    c[: n // 50] = INF
    g = ["hot" if x < 0.9 else None for x in rng.random(n)]
    rows = [(i, x, float(a[i]), float(b[i]), None if i % 7 == 0 else float(c[i]), None) for i, x in enumerate(g)]
    df = spark.createDataFrame(rows, "i int, g string, a double, b double, c double, void double").repartition(3)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    order = lambda x: (math.isnan(x), x)

    def want(values):
        s = sorted((v for v in values if v is not None), key=order)
        if not s:
            return [None] * len(probs)
        ends = [(s[math.floor(p * (len(s) - 1))], s[math.ceil(p * (len(s) - 1))], p * (len(s) - 1)) for p in probs]
        return [x if k == int(k) else (math.ceil(k) - k) * x + (k - math.floor(k)) * y for x, y, k in ends]

    for by in ([], ["g"]):
        got = {(r.g if by else 0, r.column): r.q for r in ranks.quantiles(df, ["a", "b", "c", "void"], probs, by).collect()}
        groups = {x: [r for r in rows if r[1] == x] for x in set(g)} if by else {0: rows}
        assert len(got) == 4 * len(groups) if n else not got or all(v is None for q in got.values() for v in q)
        for (k, column), q in got.items() if n else ():
            at = 2 + ["a", "b", "c", "void"].index(column)
            assert repr(q) == repr(want([r[at] for r in groups[k]])), (k, column)
