"""Queries over aggregations, profiles, orders and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import FAMILIES, combined_family
from ..operators import profile as P
from ..operators import sampling as S
from ..operators.ranks import quantiles
from .catalog import query
from .q_clean import clean
from .views import CLEAN, FLOWS, LABELED, PREDS, flows, preds, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_FAMILY_VALUES = ", ".join(f"('{x}')" for x in (*FAMILIES, "Other"))


@query("label_distribution", f"with {LABELED} select c.label, count(l.row_id) as n from (values {_FAMILY_VALUES}) c(label) left join labeled l on l.label = c.label group by c.label")
def _(spark, d):
    cats = spark.createDataFrame([(x,) for x in (*FAMILIES, "Other")], "label string")
    return P.value_counts(flows(spark, d).select(combined_family(F.col("label_raw")).alias("label")), "label", cats)


@query(
    "describe_dataset",
    f"""with {FLOWS}, s as (select count(*) as n_rows, count(distinct label_raw) as n_labels,
 sum((f_rate is null or isnan(f_rate))::int + (f_value is null)::int + (f_k is null)::int)::bigint as missing_cells, sum(coalesce(isinf(f_rate), false)::int)::bigint as infinite_cells from flows),
k as (select count(*) as c from flows group by label_raw, case when isfinite(f_rate) then f_rate end, f_k)
select s.*, (select sum(c - 1)::bigint from k) as duplicate_rows from s""",
)
def _(spark, d):
    return P.describe_dataset(flows(spark, d), ["f_rate", "f_value", "f_k"], "label_raw", ["label_raw", "f_rate", "f_k"])


@query("missing_topk", f"""with {FLOWS} select * from (select 'f_rate' as "column", count(*) filter (where f_rate is null or isnan(f_rate)) as missing from flows union all select 'f_value', count(*) filter (where f_value is null) from flows union all select 'f_user', count(*) filter (where f_user is null) from flows union all select 'f_k', count(*) filter (where f_k is null) from flows) order by missing desc, "column" limit 2""")
def _(spark, d):
    return P.top_k(P.missing_counts(flows(spark, d), ["f_rate", "f_value", "f_user", "f_k"]), "missing", 2, "column").select("column", "missing")


@query(
    "corr_topk",
    """with v as (select * from (values ('l_extendedprice'),('l_quantity'),('l_tax')) t(c)), l as (select * from lineitem)
select * from (select 'l_extendedprice' as a, 'l_quantity' as b, round(corr(l_extendedprice, l_quantity), 6) as r from l
union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) from l
union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) from l)""",
)
def _(spark, d):
    """Correlations of the three columns with the largest variance."""
    t = table(spark, d, "lineitem")
    var = P.top_k(P.stats_by_column(t, MEASURES, {"v": F.var_samp}), "v", 3, "column")
    cols = [r["column"] for r in var.collect()]  # three names
    return _rounded(P.correlation_pairs(t, cols), "r")


@query(
    "discriminative_features",
    f"""with {CLEAN}, m as (select label, avg(f_rate::double) as f_rate, avg(f_value::double) as f_value, avg(f_user::double) as f_user, avg(f_const::double) as f_const from clean group by label),
u as (unpivot m on f_rate, f_value, f_user, f_const into name "column" value v)
select "column", round(coalesce(case when avg(v) = 0 then null else stddev_samp(v) / abs(avg(v)) end, 0), 6) as score from u group by "column" order by score desc, "column" limit 3""",
)
def _(spark, d):
    c = clean(spark, d)
    c = c.select("label", *[F.col(x).cast("double").alias(x) for x in ("f_rate", "f_value", "f_user", "f_const")])
    return _rounded(P.discriminative_features(c, ["f_rate", "f_value", "f_user", "f_const"], "label", 3), "score")


@query(
    "eda_bundle",
    f"""with {CLEAN}, m as (select label, avg(f_rate::double) as f_rate, avg(f_value::double) as f_value, avg(f_user::double) as f_user, avg(f_const::double) as f_const from clean group by label),
u as (unpivot m on f_rate, f_value, f_user, f_const into name "column" value v),
g as (select count(*) filter (where f_rate is null) as f_rate, count(*) filter (where f_value is null) as f_value, count(*) filter (where f_user is null) as f_user, count(*) filter (where f_const is null) as f_const from clean),
gaps as (unpivot g on f_rate, f_value, f_user, f_const into name "column" value v)
select 'rows' as metric, '' as name, count(*)::double as value from clean union all select 'label', label, count(*)::double from clean group by label
union all select 'missing', * from (select "column", v::double as v from gaps order by v desc, "column" limit 3)
union all select 'variance', 'f_value', round(var_samp(f_value::double), 4) from clean union all select 'variance', 'f_rate', round(var_samp(f_rate::double), 4) from clean
union all select 'variance', 'f_user', round(var_samp(f_user::double), 4) from clean union all select 'variance', 'f_const', round(var_samp(f_const::double), 4) from clean
union all select 'correlation', 'f_rate|f_value', round(corr(f_rate::double, f_value::double), 6) from clean union all select 'correlation', 'f_rate|f_user', round(corr(f_rate::double, f_user::double), 6) from clean
union all select 'correlation', 'f_value|f_user', round(corr(f_value::double, f_user::double), 6) from clean
union all select 'discriminative', * from (select "column", round(coalesce(case when avg(v) = 0 then null else stddev_samp(v) / abs(avg(v)) end, 0), 6) as score from u group by "column" order by score desc, "column" limit 3)""",
)
def _(spark, d):
    """Clean and mapped flows in one table: rows, labels, gaps, variances, correlations, the columns that tell classes apart."""
    cols = ["f_rate", "f_value", "f_user", "f_const"]
    c = clean(spark, d).select("label", *[F.col(x).cast("double").alias(x) for x in cols])
    rows = c.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), F.lit("").alias("name"), "value")
    labels = c.groupBy("label").agg(F.count("*").cast("double").alias("value")).select(F.lit("label"), "label", "value")
    gaps = P.top_k(P.missing_counts(c, cols), "missing", 3, "column").select(F.lit("missing"), "column", F.col("missing").cast("double"))
    var = P.stats_by_column(c, cols, {"v": lambda x: F.round(F.var_samp(x), 4)}).select(F.lit("variance"), "column", "v")
    corr = P.correlation_pairs(c, cols[:3]).select(F.lit("correlation"), F.concat_ws("|", "a", "b"), F.round("r", 6))
    tells = P.discriminative_features(c, cols, "label", 3).select(F.lit("discriminative"), "column", F.round("score", 6))
    return rows.union(labels).union(gaps).union(var).union(corr).union(tells)


@query("class_quartiles", f"with {CLEAN} select label, round(quantile_cont(f_value::double, 0.25), 6) as q1, round(quantile_cont(f_value::double, 0.5), 6) as q2, round(quantile_cont(f_value::double, 0.75), 6) as q3 from clean group by label")
def _(spark, d):
    q = quantiles(clean(spark, d), ["f_value"], [0.25, 0.5, 0.75], ["label"])
    return q.select("label", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@query("class_profile", "select l_returnflag, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std, min(l_extendedprice) as lo, max(l_extendedprice) as hi, round(quantile_cont(l_extendedprice, 0.05), 6) as p05, round(quantile_cont(l_extendedprice, 0.95), 6) as p95 from lineitem group by l_returnflag")
def _(spark, d):
    g = P.class_profile(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return _rounded(g, "mean", "std", "p05", "p95")


@query("majority_baseline", f"with {CLEAN}, c as (select count(*) as n from clean group by label) select round(max(n) / sum(n)::double, 9) as baseline from c")
def _(spark, d):
    return P.majority_baseline(clean(spark, d), "label").select(F.round("baseline", 9).alias("baseline"))


@query("label_positions", f"with {LABELED}, e as (select source_file, greatest(max(row_index), 1) as dd from labeled group by 1) select l.source_file, label, count(*) as n, round(min(row_index) / any_value(dd)::double, 9) as min_pos, round(quantile_cont(row_index::double, 0.5) / any_value(dd)::double, 9) as median_pos, round(max(row_index) / any_value(dd)::double, 9) as max_pos from labeled l join e using (source_file) group by l.source_file, label")
def _(spark, d):
    f = flows(spark, d).select("source_file", "row_index", combined_family(F.col("label_raw")).alias("label"))
    return S.label_positions(f, "source_file", "label", "row_index").select("source_file", "label", "n", *[F.round(c, 9).alias(c) for c in ("min_pos", "median_pos", "max_pos")])


_SAMPLE = "md5(concat_ws(':', '42', label, row_id::varchar)) < '30'"


@query("sample_vs_corpus", f"with {CLEAN}, c as (select label, count(*) as n, count(*) filter (where {_SAMPLE}) as k from clean group by label) select label, n as corpus_n, k as sample_n, round(n / sum(n) over (), 9) as corpus_share, round(k / sum(k) over (), 9) as sample_share from c")
def _(spark, d):
    c = clean(spark, d)
    a = P.shares(c, "label").toDF("label", "corpus_n", "corpus_share")
    b = P.shares(c.where(S.sample_key(42, F.col("label"), F.col("row_id")) < "30"), "label").toDF("label", "sample_n", "sample_share")
    j = a.join(b, "label", "left").na.fill(0)
    return j.select("label", "corpus_n", "sample_n", F.round("corpus_share", 9).alias("corpus_share"), F.round("sample_share", 9).alias("sample_share"))


@query("predicted_share", f"with {PREDS} select y_pred as label, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from preds where model = 1 group by y_pred")
def _(spark, d):
    return P.shares(preds(spark, d).where("model = 1"), "y_pred").withColumn("share", F.round("share", 9))


@query("overview", f"with {LABELED} select label, count(*) filter (where row_id % 10 < 7) as train_n, count(*) filter (where row_id % 10 >= 7) as test_n, count(*) as total_n from labeled group by label")
def _(spark, d):
    f = flows(spark, d).select("row_id", combined_family(F.col("label_raw")).alias("label"))
    train = f.where("row_id % 10 < 7").groupBy("label").agg(F.count("*").alias("n")).withColumn("side", F.lit("train"))
    test = f.where("row_id % 10 >= 7").groupBy("label").agg(F.count("*").alias("n")).withColumn("side", F.lit("test"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    return train.union(test).groupBy("label").agg(side("train").alias("train_n"), side("test").alias("test_n"), F.sum("n").alias("total_n"))


@query("capture_class_rank", f"with {LABELED} select row_id, (row_number() over (partition by source_file, label order by row_index, row_id)) as rank from labeled")
def _(spark, d):
    """Chronological rank inside (source, class)."""
    f = flows(spark, d).select("row_id", "row_index", "source_file", combined_family(F.col("label_raw")).alias("label"))
    return S.chronological_rank(f, ["source_file", "label"], "row_index", "row_id").select("row_id", "rank")


@query("file_offsets", f"with {FLOWS}, c as (select source_file, count(*) as n from flows group by 1) select source_file, n, coalesce(sum(n) over (order by source_file rows between unbounded preceding and 1 preceding), 0)::bigint as file_offset from c")
def _(spark, d):
    c = flows(spark, d).groupBy("source_file").agg(F.count("*").alias("n"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return c.withColumn("file_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


_SUMMARY = f"""{FLOWS}, s as (select count(*) as n_rows, count(distinct label_raw) as n_labels,
 count(*) filter (where f_rate is null or isnan(f_rate)) as m_rate, count(*) filter (where f_value is null) as m_value, count(*) filter (where f_k is null) as m_k,
 count(*) filter (where isinf(f_rate)) as i_rate, count(*) filter (where isinf(f_value)) as i_value, count(*) filter (where isinf(f_k)) as i_k from flows),
k as (select count(*) as c from flows group by label_raw, case when isfinite(f_rate) then f_rate end, f_k),
summary as (select 'n_rows' as metric, '' as name, n_rows as value from s union all select 'n_labels', '', n_labels from s
union all select 'missing_cells', '', m_rate + m_value + m_k from s union all select 'infinite_cells', '', i_rate + i_value + i_k from s
union all select 'duplicate_rows', '', (select sum(c - 1)::bigint from k)
union all select 'type', * from (values ('bigint', 2), ('date', 1), ('double', 5), ('string', 2), ('timestamp_ntz', 1)) t
union all select 'missing', * from (select * from (select 'f_rate' as c, m_rate as m from s union all select 'f_value', m_value from s union all select 'f_k', m_k from s) order by m desc, c limit 2)
union all select 'infinite', * from (select 'f_rate' as c, i_rate as n from s union all select 'f_value', i_value from s union all select 'f_k', i_k from s) where n > 0
union all select 'label', label_raw, count(*) from flows group by label_raw)"""


@query("dataset_summary", f"with {_SUMMARY} select * from summary")
def _(spark, d):
    """Shape, types, missing and infinite cells, repeats and labels of the dirty flows."""
    return P.dataset_summary(flows(spark, d), ["f_rate", "f_value", "f_k"], "label_raw", ["label_raw", "f_rate", "f_k"], 2)
