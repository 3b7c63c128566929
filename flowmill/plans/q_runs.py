"""Queries over stored results: bundles, manifests, caches, sinks, the scoring stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import combined_family, finite_or_null
from ..operators import metrics as M
from ..operators import sampling as S
from ..sources import bundles, caches, captures
from ..streaming import score_stream as ST
from ..streaming import score_uploads as SU
from .catalog import query
from .q_clean import clean
from .q_evaluate import METRICS, cm
from .q_split import nested_sql
from .views import CLEAN, FLOWS, LABELED, flows


@query("normalize_runs", f"with {METRICS} select 'a' as bundle, model, round(accuracy, 8) as accuracy, round(f1_macro, 8) as f1_macro, null::double as f1_weighted, case when model = 1 then null else 10.0::double + model end as p95_ms from mm union all select 'b', model, null, round(f1_macro, 8), round(f1_weighted, 8), null from mm")
def _(spark, d):
    """Two result layouts (JSON documents with a NaN, CSV tables) written, read and brought into one nullable schema."""
    m = M.model_metrics(M.marginals(cm(spark, d))).select("model", *[F.round(c, 8).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])
    path = captures.scratch_path(spark, "bundles")
    latency = F.when(F.col("model") == 1, "NaN").otherwise((10.0 + F.col("model")).cast("string"))
    m.select("model", F.struct("accuracy", "f1_macro").alias("metrics"), F.struct(latency.alias("p95_ms")).alias("cost")).write.json(f"{path}/a")
    m.select("model", "f1_macro", "f1_weighted").write.option("header", True).csv(f"{path}/b")
    return bundles.normalize_runs([bundles.read_json_bundle(spark, f"{path}/a", "a"), bundles.read_csv_bundle(spark, f"{path}/b", "b")])


@query("index_cache")
def _(spark, d):
    """Files of a written label index with the fingerprint by which a cache is judged stale."""
    path = captures.scratch_path(spark, "label-index")
    clean(spark, d).select("source_file", "row_index", "label").write.partitionBy("source_file").parquet(path)
    return bundles.file_fingerprints(spark, path).groupBy("folder").agg(F.count("*").alias("files"), F.max((F.col("size") > 0).cast("int")).alias("nonempty"))


@query("cached_index", f"with {FLOWS} select 'first' as step, true as built, count(*) filter (where row_id % 2 = 0) as n_rows from flows union all select 'again', false, count(*) filter (where row_id % 2 = 0) from flows union all select 'more files', true, count(*) from flows")
def _(spark, d):
    """A label index built, loaded while its inputs stay, and rebuilt when files were added."""
    path, inputs = captures.scratch_path(spark, "cached-index"), captures.scratch_path(spark, "index-inputs")
    f = flows(spark, d).select("row_id", "source_file", "row_index", "label_raw")
    index = lambda df: df.select("source_file", "row_index", combined_family(F.col("label_raw")).alias("label"))
    rows = []
    for step, part in (("first", f.where("row_id % 2 = 0")), ("again", None), ("more files", f.where("row_id % 2 <> 0"))):
        if part is not None:
            part.write.mode("append").parquet(inputs)
        df, built = caches.load_or_build(spark, path, inputs, index)
        rows.append((step, built, df.count()))
    return spark.createDataFrame(rows, "step string, built boolean, n_rows long")


@query("manifest_diff", "select * from (values ('hash', 1::bigint), ('missing', 1), ('path escape', 1)) t(problem, n)")
def _(spark, d):
    """Files against their declared sizes and SHA-256: one is declared wrong, one doesn't exist."""
    path = captures.scratch_path(spark, "artifacts")
    clean(spark, d).groupBy("label").agg(F.count("*").alias("n")).repartition(3, "label").write.json(path)
    return bundles.manifest_diff_demo(spark, path)


@query("sample_cache", f"with {CLEAN}, " + nested_sql("clean", "label", "row_id", "(select count(*) // 2 from clean)", 5, "42", "label, count(*) as n", " group by label"))
def _(spark, d):
    """A sized sample cached under its size and loaded again; its row count must match."""
    inputs = captures.scratch_path(spark, "sample-inputs")
    clean(spark, d).write.parquet(inputs)
    size = spark.read.parquet(inputs).count() // 2
    path = captures.scratch_path(spark, f"sample-{size}")
    for _ in range(2):
        sample, built = caches.load_or_build(spark, path, inputs, lambda c: S.nested_sample(c, "label", "row_id", size, 5), n_rows=size)
    if built:
        raise ValueError("the sample was built twice from the same inputs")
    return sample.groupBy("label").agg(F.count("*").alias("n"))


@query("result_sinks", "select 0::bigint as differing")
def _(spark, d):
    """Matrices and metrics to partitioned Parquet and JSON, read back: differing cells (none)."""
    path = captures.scratch_path(spark, "results")
    c = cm(spark, d)
    c.withColumn("run_id", F.lit("r1")).write.partitionBy("run_id").parquet(f"{path}/confusion")
    return M.confusion_diff(c, spark.read.parquet(f"{path}/confusion").drop("run_id")).agg(F.count("*").alias("differing"))


@query("score_stream", f"with {LABELED} select label, case when isfinite(f_rate) and f_rate > 50 then 'Attack' else 'Normal' end as decision, count(*) as n from labeled group by all")
def _(spark, d):
    """Flows written as files, scored by a file stream into Parquet, counted by class and decision."""
    path = captures.scratch_path(spark, "stream")
    src = flows(spark, d).select("row_id", "label_raw", "f_rate", "f_value")
    src.repartition(4, "row_id").write.parquet(f"{path}/in")
    stream = ST.read_flow_stream(spark, f"{path}/in", src.schema)
    rule = lambda df: F.when(F.coalesce(F.col("f_rate"), F.lit(0.0)) > 50, "Attack").otherwise("Normal")
    ST.score_to_parquet(ST.score_rows(stream, ["f_rate", "f_value"], rule), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("label", "decision").agg(F.count("*").alias("n"))


@query("runs_with_sides", f"with {METRICS} select 'a' as bundle, model, round(f1_macro, 8) as f1_macro, case when model < 3 then round(f1_weighted, 8) end as f1_weighted, case when model <> 1 then round(f1_macro, 8) - 0.01 end as ci_low from mm")
def _(spark, d):
    """A discovered bundle whose metrics are joined with its side files, each of which lacks a model."""
    m = M.model_metrics(M.marginals(cm(spark, d))).select("model", *[F.round(c, 8).alias(c) for c in ("f1_macro", "f1_weighted")])
    root = captures.scratch_path(spark, "discovered")
    m.select("model", "f1_macro").write.option("header", True).csv(f"{root}/a/metrics")
    m.where("model < 3").select("model", "f1_weighted").write.option("header", True).csv(f"{root}/a/extended")
    m.where("model <> 1").select("model", (F.col("f1_macro") - 0.01).alias("ci_low")).write.option("header", True).csv(f"{root}/a/ci")
    found = {r["folder"] for r in bundles.discover(spark, root).collect()}  # a row a folder
    runs = bundles.join_sides(spark.read.option("header", True).csv(f"{root}/a/metrics"), [spark.read.option("header", True).csv(f"{root}/a/{s}") for s in ("extended", "ci") if s in found], "model")
    number = [F.col(c).cast("double").alias(c) for c in ("f1_macro", "f1_weighted", "ci_low")]
    return runs.select(F.lit("a").alias("bundle"), F.col("model").cast("int").alias("model"), *number)


@query("result_files", f"with {METRICS} select 'metrics' as part, model, round(sum(f1_macro), 8) as value from mm group by model union all select 'confusion', model, count(*)::double from preds group by model union all select 'folders', null, 2")
def _(spark, d):
    """Metrics as JSON and matrices as CSV written as a bundle, found below its root and read again."""
    c = cm(spark, d)
    m = M.model_metrics(M.marginals(c)).select("model", F.struct("f1_macro").alias("metrics"))
    path = captures.scratch_path(spark, "result-files")
    bundles.write_results(m, {"confusion": c}, path)
    metrics = spark.read.schema("model int, metrics struct<f1_macro: double>").json(f"{path}/metrics").select(F.lit("metrics").alias("part"), "model", F.round("metrics.f1_macro", 8).alias("value"))
    cells = spark.read.option("header", True).schema(c.schema).csv(f"{path}/confusion").groupBy("model").agg(F.sum("n").cast("double").alias("value"))
    folders = bundles.discover(spark, path).agg(F.count("*").cast("double").alias("value")).select(F.lit("folders"), F.lit(None).cast("int"), "value")
    return metrics.union(cells.select(F.lit("confusion"), "model", "value")).union(folders)


@query("score_uploads", f"with {LABELED}, u as (select label, case when row_id % 13 = 0 then 'number:f_value' when isfinite(f_rate) and f_rate > 50 then 'Attack' else 'Normal' end as decision from labeled) select label, decision, count(*) as n, (select count(*) from labeled) as n_rows, (select count(*) from labeled where row_id % 13 = 0) as n_quarantined from u group by all")
def _(spark, d):
    """Flows uploaded as CSVs, every thirteenth with an unreadable number: scored, set aside and counted by a stream."""
    path = captures.scratch_path(spark, "uploads")
    src = flows(spark, d).select("row_id", combined_family(F.col("label_raw")).alias("label"), "f_rate", F.when(F.expr("row_id % 13 = 0"), "12,5x").otherwise(F.col("f_value").cast("string")).alias("f_value"))
    src.repartition(5, "row_id").write.option("header", True).csv(f"{path}/in")
    stream = SU.read_uploads(spark, f"{path}/in", src.columns, 2)
    rule = F.when(F.coalesce(finite_or_null(F.col("f_rate")), F.lit(0.0)) > 50, "Attack").otherwise("Normal")
    SU.score_uploads(stream, ["f_rate", "f_value"], lambda df: df.select("row_id", "label", rule.alias("decision")), f"{path}/out", f"{path}/state").awaitTermination()
    every = SU.read_part(spark, f"{path}/out", "scored").select("label", "decision").unionByName(SU.read_part(spark, f"{path}/out", "quarantine").select("label", F.col("_fault").alias("decision")))
    counts = SU.read_part(spark, f"{path}/out", "counts").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_quarantined").alias("n_quarantined"))
    return every.groupBy("label", "decision").agg(F.count("*").alias("n")).join(F.broadcast(counts))
