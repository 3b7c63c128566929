"""Queries over sources, schemas, cleaning, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import combined_family, finite_or_null, normalize_raw_label
from ..operators import clean as C
from ..operators import sampling as S
from ..sources import caches, captures
from .catalog import query
from .views import CLEAN, FLOWS, LABELED, PREDS, flows, preds, table

FEATURES = ["f_rate", "f_value", "f_user", "f_k", "f_const"]
EXPECTED = ["row_id", "row_index", "source_file", "label_raw", "f_rate", "f_value", "f_user", "f_k", "f_const", "f_missing"]


def cleaned(dirty):
    return C.clean_flows(dirty, "label_raw", FEATURES).select("row_id", "row_index", "ts", "capture_day", "source_file", "label", *FEATURES)


def clean(spark, d):
    return cleaned(flows(spark, d))


@query("scan_flows")
def _(spark, d):
    """Flows written as one CSV folder a source, scanned as text, with their row numbers in the file."""
    src = flows(spark, d).selectExpr("source_file", "row_id", "label_raw as ` Label`", "cast(f_rate as string) as `f_rate `", "cast(f_value as string) as f_value")
    path = captures.write_captures(src, captures.scratch_path(spark, "captures"), "source_file")
    placed = captures.row_positions(captures.scan_captures(spark, path))
    out = C.strip_columns(placed)
    return out.groupBy("source_file", normalize_raw_label(F.col("Label")).alias("label")).agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))


@query("scan_label_counts", f"with {FLOWS} select trim(regexp_replace(regexp_replace(label_raw, '[^\\x20-\\x7E]', ' ', 'g'), ' +', ' ', 'g')) as label, count(*) as n, count(distinct source_file) as n_sources from flows group by 1")
def _(spark, d):
    """Label counts of flows written as one CSV folder a source and scanned as text."""
    src = flows(spark, d).selectExpr("source_file", "row_id", "label_raw as ` Label`", "cast(f_value as string) as f_value")
    path = captures.write_captures(src, captures.scratch_path(spark, "captures"), "source_file")
    out = C.strip_columns(captures.scan_captures(spark, path))
    return out.groupBy(normalize_raw_label(F.col("Label")).alias("label")).agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("n_sources"))


@query("strip_columns", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey as ` l_orderkey`", "l_linenumber as `l_linenumber  `", "l_quantity as ` l_quantity `")
    return C.strip_columns(t)


@query("schema_report", f"with {FLOWS} select 'f_missing' as \"column\", 'missing' as status, 0::bigint as n_filled union all select 'ts', 'extra', count(ts) from flows union all select 'capture_day', 'extra', count(capture_day) from flows")
def _(spark, d):
    """Missing and extra columns of a stored capture, with the filled cells of each extra one."""
    path = captures.scratch_path(spark, "capture")
    flows(spark, d).write.parquet(path)
    stored = spark.read.parquet(path)
    extra = [c for c in stored.columns if c not in EXPECTED]
    filled = stored.agg(*[F.count(c).alias(c) for c in extra]).unpivot([], extra, "column", "n_filled")  # a row a column
    return C.schema_report(spark, stored.columns, EXPECTED).join(F.broadcast(filled), "column", "left").na.fill(0, ["n_filled"])


@query("labels_outside_domain", f"with {LABELED} select distinct label from labeled where label not in ('BENIGN','DoS','DDoS','PortScan','Bot','Web Attack','Brute Force','Infiltration','Heartbleed')")
def _(spark, d):
    from ..functions.labels import FAMILIES

    allowed = spark.createDataFrame([(x,) for x in FAMILIES], "label string")
    return flows(spark, d).select(combined_family(F.col("label_raw")).alias("label")).distinct().join(allowed, "label", "left_anti")


@query("upload_report", "select 'f_missing' as missing, 'capture_day,ts' as extra, false as valid, count(*) as n_rows from events")
def _(spark, d):
    f = flows(spark, d)
    r = C.schema_report(spark, f.columns, EXPECTED)
    names = lambda s: F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("column")))), ","), F.lit(""))
    report = r.agg(names("missing").alias("missing"), names("extra").alias("extra"), (F.count_if(F.col("status") == "missing") == 0).alias("valid"))
    return report.join(f.agg(F.count("*").alias("n_rows")))


@query("align_columns", f"with {FLOWS} select f_k, f_value, row_id from flows")
def _(spark, d):
    return C.align_columns(flows(spark, d), ["f_k", "f_value", "row_id"])


@query("missing_sources", "select * from (values ('cap_8'), ('cap_9')) t(source_file)")
def _(spark, d):
    need = spark.createDataFrame([(f"cap_{k}",) for k in range(10)], "source_file string")
    return need.join(flows(spark, d).select("source_file").distinct(), "source_file", "left_anti")


@query("row_position", f"with {FLOWS} select source_file, row_id, (row_number() over (partition by source_file order by row_id) - 1) as position from flows")
def _(spark, d):
    return captures.positions_by_order(flows(spark, d).select("source_file", "row_id"), "source_file", "row_id")


@query("clean_flows", f"with {CLEAN} select row_id, source_file, label, f_rate, f_value, f_user, f_k, f_const from clean")
def _(spark, d):
    return clean(spark, d).select("row_id", "source_file", "label", *FEATURES)


@query("clean_corpus", f"with {CLEAN} select source_file, label, count(*) as n, min(row_index) as first_row from clean group by all")
def _(spark, d):
    """The clean corpus cached as Parquet, loaded again while its inputs stay, and checked for gaps."""
    path, inputs = captures.scratch_path(spark, "clean-corpus"), captures.scratch_path(spark, "corpus-inputs")
    flows(spark, d).write.parquet(inputs)
    caches.load_or_build(spark, path, inputs, cleaned)
    back, built = caches.load_or_build(spark, path, inputs, cleaned)
    if built:
        raise ValueError("the clean corpus was built twice from the same inputs")
    C.require_no_gaps(back, ["label", *FEATURES])
    return back.groupBy("source_file", "label").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


@query(
    "corpus_summary",
    f"with {CLEAN} select label, count(*) as n, count(distinct source_file) as sources, string_agg(distinct source_file, ',' order by source_file) as source_list from clean group by label",
)
def _(spark, d):
    g = clean(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source_file")).alias("s"))
    return g.select("label", "n", F.size("s").cast("long").alias("sources"), F.array_join("s", ",").alias("source_list"))


@query("label_index", f"with {LABELED} select source_file, row_index, case when label = 'Other' then null else label end as label from labeled")
def _(spark, d):
    """Label of every row, null where it is unusable; only three columns are read."""
    fam = combined_family(F.col("label_raw"))
    return flows(spark, d).select("source_file", "row_index", F.when(fam != "Other", fam).alias("label"))


@query("materialize_sample", f"with {CLEAN} select row_id, label, f_value from clean where (source_file, row_index) in (select source_file, row_index from clean where md5(concat_ws(':', '7', label, row_id::varchar)) < '20')")
def _(spark, d):
    c = clean(spark, d)
    chosen = c.where(S.sample_key(7, F.col("label"), F.col("row_id")) < "20").select("source_file", "row_index")
    return captures.materialize_rows(c, chosen, "source_file", "row_index").select("row_id", "label", "f_value")


@query("alignment_mismatches", f"with {CLEAN} select count(*) as n_rows, count(*) filter (where l.label <> c.label) as mismatches from labeled l join clean c using (source_file, row_index)")
def _(spark, d):
    index = flows(spark, d).select("source_file", "row_index", combined_family(F.col("label_raw")).alias("label"))
    return captures.alignment_mismatches(index, clean(spark, d), ["source_file", "row_index"], "label")


_MESSY = "case when l_orderkey % 7 = 0 then 'n/a' when l_orderkey % 11 = 0 then '' when l_orderkey % 13 = 0 then 'Infinity' else cast({0} as {1}) end"


@query(
    "coercion_report",
    f"""with m as (select {_MESSY.format('l_linenumber', 'varchar')} as a, {_MESSY.format('l_orderkey', 'varchar')} as b from lineitem)
select 'a' as "column", count(*) filter (where a is not null and try_cast(a as double) is null) as failed from m
union all select 'b', count(*) filter (where b is not null and try_cast(b as double) is null) from m""",
)
def _(spark, d):
    m = table(spark, d, "lineitem").selectExpr(_MESSY.format("l_linenumber", "string") + " as a", _MESSY.format("l_orderkey", "string") + " as b")
    return C.coercion_report(m, ["a", "b"])


@query("coerce_numeric", f"select l_orderkey, l_linenumber, case when isinf(v) then null else v end as v from (select l_orderkey, l_linenumber, try_cast({_MESSY.format('l_linenumber', 'varchar')} as double) as v from lineitem)")
def _(spark, d):
    m = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", _MESSY.format("l_linenumber", "string") + " as v")
    return C.coerce_numeric(m, ["v"])


@query("finite_or_null", f"with {FLOWS} select row_id, case when isfinite(f_rate) then f_rate end as f_rate from flows")
def _(spark, d):
    return flows(spark, d).select("row_id", finite_or_null(F.col("f_rate")).alias("f_rate"))


_SHAPE = "row_id,row_index,ts,capture_day,source_file,label,f_rate,f_value,f_user,f_k,f_const"


@query("dataset_fingerprint", f"with {CLEAN}, c as (select label, count(*) as n from clean group by label), s as (select coalesce(string_agg(label || '=' || n::varchar, ';' order by label), '') as labels, coalesce(sum(n), 0)::bigint as n_rows from c) select sha256(n_rows::varchar || 'x11;{_SHAPE};' || labels) as fingerprint, n_rows, 11 as n_columns from s")
def _(spark, d):
    return S.dataset_fingerprint(clean(spark, d), "label")


@query("clean_switchable", f"with {FLOWS}, f as (select label_raw, case when isfinite(f_rate) then f_rate end as f_rate, f_k from flows) select distinct * from f where f_rate is not null and f_k is not null and label_raw is not null")
def _(spark, d):
    return C.clean_switchable(flows(spark, d).select("label_raw", "f_rate", "f_k"), ["f_rate", "f_k"])


@query("drop_header_rows", f"with {FLOWS} select row_id, label_raw from flows where trim(label_raw) <> 'Label'")
def _(spark, d):
    return C.drop_header_rows(flows(spark, d), "label_raw").select("row_id", "label_raw")


@query("null_nonfinite", f"with {FLOWS} select row_id, case when isfinite(f_rate) then f_rate end as f_rate, f_value from flows")
def _(spark, d):
    return C.null_nonfinite(flows(spark, d), ["f_rate", "f_value"]).select("row_id", "f_rate", "f_value")


@query("drop_null_rows", f"with {FLOWS} select row_id from flows where not isnan(f_rate) and f_value is not null")
def _(spark, d):
    return C.drop_null_rows(flows(spark, d), ["f_rate", "f_value"]).select("row_id")


@query("downcast", f"with {FLOWS} select row_id, f_value::float as f_value from flows")
def _(spark, d):
    return flows(spark, d).select("row_id", F.col("f_value").cast("float").alias("f_value"))


@query("filter_classes", f"with {CLEAN} select row_id, label from clean where label in ('DoS','Bot')")
def _(spark, d):
    return C.keep_classes(clean(spark, d), "label", ["DoS", "Bot"]).select("row_id", "label")


@query("drop_other", f"with {LABELED} select row_id, label from labeled where label <> 'Other'")
def _(spark, d):
    return C.drop_other(flows(spark, d).select("row_id", combined_family(F.col("label_raw")).alias("label")), "label")


@query("drop_tiny_classes", f"with {CLEAN}, n as (select *, count(*) over (partition by label) as c from clean) select row_id, label from n where c >= 100")
def _(spark, d):
    return C.drop_tiny_classes(clean(spark, d), "label", 100).select("row_id", "label")


@query("feature_projection", f"with {CLEAN} select f_rate, f_value, f_user, f_k, f_const, label from clean")
def _(spark, d):
    c = clean(spark, d).drop("row_id", "row_index", "ts", "capture_day", "source_file")
    return C.assert_absent(c, "ts", "row_index").select(*FEATURES, "label")


@query("parse_ts", "select event_id, case when event_id % 50 = 3 then null else date_trunc('second', ts) end as ts from events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 3, F.lit("31/31/2018 99:00:00")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).alias("t"))
    return e.select("event_id", C.parse_timestamp(F.col("t")).cast("timestamp_ntz").alias("ts"))


@query("union_flows", "select event_id, value, null::bigint as user_id from events where event_id % 2 = 0 union all select event_id, null, user_id from events where event_id % 2 = 1")
def _(spark, d):
    e = table(spark, d, "events")
    return C.union_frames([e.where("event_id % 2 = 0").select("event_id", "value"), e.where("event_id % 2 = 1").select("event_id", "user_id")])


@query(
    "dedup_flows",
    """with r as (select *, row_number() over (partition by l_returnflag, l_linestatus, l_quantity, l_discount, l_tax order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from lineitem)
select l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_orderkey, l_linenumber from r where rn = 1""",
)
def _(spark, d):
    """Distinct measures, with the metadata of their first row."""
    data, meta = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"]
    return C.dedup_keep_first(table(spark, d, "lineitem"), data, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], meta)


@query("pair_predictions", f"with {PREDS} select row_id, y_true, max(case when model=0 then y_pred end) as p0, max(case when model=1 then y_pred end) as p1, max(case when model=2 then y_pred end) as p2, max(case when model=3 then y_pred end) as p3 from preds group by all")
def _(spark, d):
    """Truth beside every model's prediction, a row an observation."""
    return preds(spark, d).groupBy("row_id", "y_true").pivot("model", [0, 1, 2, 3]).agg(F.first("y_pred")).toDF("row_id", "y_true", "p0", "p1", "p2", "p3")
