"""Queries over splits, samples, folds and their manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import normalize_raw_label
from ..operators import sampling as S
from ..sources import captures, manifests
from .catalog import query
from .q_clean import clean
from .views import CLEAN, FLOWS, flows, table

_CUT = "greatest(1, least(n - 1, floor(n * (1.0::double - 0.3::double))::bigint))"
SPLIT = f"""{CLEAN}, g as (select *, row_number() over (partition by source_file, label order by row_index, row_id) as rn, count(*) over (partition by source_file, label) as n from clean),
split as (select *, case when n = 1 or rn <= {_CUT} then 'train' else 'test' end as side from g)"""
MANIFEST = "select label, count(*) filter (where side = 'train') as n_train, count(*) filter (where side = 'test') as n_test from split group by label"


def _ordered(label: str, seed: int, source: str = "clean", row: str = "row_id") -> str:
    """DuckDB: rank of each row in its class's fixed random order, and the class size."""
    return f"r as (select *, row_number() over (partition by {label} order by md5(concat_ws(':', '{seed}', {label}, {row}::varchar)), {row}) as rn, count(*) over (partition by {label}) as n from {source})"


def split(spark, d):
    return S.chronological_split(clean(spark, d), ["source_file", "label"], "row_index", "row_id")


@query("temporal_split", f"with {SPLIT} select row_id, source_file, label, side from split")
def _(spark, d):
    return split(spark, d).select("row_id", "source_file", "label", "side")


@query("temporal_split_skewed", f"with {SPLIT} select row_id, source_file, label, side from split")
def _(spark, d):
    """The same split with groups cut into ranges."""
    return S.chronological_split(clean(spark, d), ["source_file", "label"], "row_index", "row_id", buckets=16, range_rows=20).select("row_id", "source_file", "label", "side")


_BY_DAY = f"""{CLEAN}, g as (select *, row_number() over (partition by capture_day, label order by ts, row_id) as rn, count(*) over (partition by capture_day, label) as n from clean),
split as (select *, case when n = 1 or rn <= {_CUT} then 'train' else 'test' end as side from g)"""


def by_day(spark, d):
    return S.chronological_split(clean(spark, d), ["capture_day", "label"], "ts", "row_id")


@query("temporal_split_by_day", f"with {_BY_DAY} select row_id, label, side from split")
def _(spark, d):
    return by_day(spark, d).select("row_id", "label", "side")


@query("thin_test_classes", f"with {_BY_DAY}, m as ({MANIFEST}) select label, n_test from m where n_test > 0 and n_test < 10")
def _(spark, d):
    return S.require_test_rows(by_day(spark, d), "label", 10)


@query("split_manifest", f"with {SPLIT} {MANIFEST}")
def _(spark, d):
    return S.split_manifest(split(spark, d), "label")


@query("manifest_mismatches", f"with {SPLIT}, m as ({MANIFEST}), x as (select case when label = 'Bot' then 'Worm' else label end as label, n_train + (label = 'DoS')::int as n_train, n_test from m) select coalesce(m.label, x.label) as label, coalesce(m.n_train, 0) as actual_train, coalesce(x.n_train, 0) as declared_train, coalesce(m.n_test, 0) as actual_test, coalesce(x.n_test, 0) as declared_test from m full join x on m.label = x.label where coalesce(m.n_train, 0) <> coalesce(x.n_train, 0) or coalesce(m.n_test, 0) <> coalesce(x.n_test, 0)")
def _(spark, d):
    """The split against a manifest with one class renamed and one count off."""
    m = S.split_manifest(split(spark, d), "label")
    declared = m.select(F.when(F.col("label") == "Bot", "Worm").otherwise(F.col("label")).alias("label"), (F.col("n_train") + (F.col("label") == "DoS").cast("int")).alias("n_train"), "n_test")
    return S.manifest_mismatches(m, declared)


_LOST = MANIFEST.replace("from split", "from split where source_file <> 'cap_7'")


@query("stored_manifest", f"with {SPLIT}, m as ({MANIFEST}), x as ({_LOST}) select coalesce(m.label, x.label) as label, coalesce(x.n_train, 0) as actual_train, coalesce(m.n_train, 0) as declared_train, coalesce(x.n_test, 0) as actual_test, coalesce(m.n_test, 0) as declared_test from m full join x on m.label = x.label where coalesce(m.n_train, 0) <> coalesce(x.n_train, 0) or coalesce(m.n_test, 0) <> coalesce(x.n_test, 0)")
def _(spark, d):
    """The split's manifest stored as JSON, loaded and validated; then a split that lost a capture is held against it."""
    s = split(spark, d)
    path = captures.scratch_path(spark, "manifest")
    manifests.store_manifest(manifests.build_manifest(s, "label", "source_file", "chronological_v1", "flows"), path)
    loaded = manifests.require_valid(manifests.load_manifests(spark, path), "chronological", "flows", [f"cap_{k}" for k in range(8)])
    return S.manifest_mismatches(S.split_manifest(s.where("source_file <> 'cap_7'"), "label"), manifests.declared_counts(loaded))


_SCHEDULE = [(f"cap_{k}", x, i) for k in range(8) for i, x in enumerate(["BENIGN", "DoS", "Web Attack", "Bot"])]


@query(
    "chronology_violations",
    f"""with {CLEAN}, p as (select source_file, label, quantile_cont(row_index::double, 0.5) / greatest(any_value(mx), 1) as mid from (select *, max(row_index) over (partition by source_file) as mx from clean) group by all),
s as (select * from (values ('BENIGN',0),('DoS',1),('Web Attack',2),('Bot',3)) t(label, seq)),
w as (select p.source_file, lag(p.label) over o as left_label, lag(seq) over o as ls, p.label as right_label, seq from p join s using (label) window o as (partition by p.source_file order by mid, p.label))
select source_file, left_label, right_label from w where ls > seq""",
)
def _(spark, d):
    schedule = spark.createDataFrame(_SCHEDULE, "source_file string, label string, seq int")
    return S.chronology_violations(S.label_positions(clean(spark, d), "source_file", "label", "row_index"), schedule, "source_file", "label")


_SUBLABELS = ["DoS Hulk", "FTP-Patator", "dos slowloris", "Web Attack XSS", "Bot"]
_POSITION = "cast(row_number() over (partition by source_file order by row_index) - 1 as double)"


@query(
    "sublabel_chronology",
    f"""with {FLOWS}, p as (select source_file, trim(regexp_replace(regexp_replace(label_raw, '[^\\x20-\\x7E]', ' ', 'g'), ' +', ' ', 'g')) as label, {_POSITION} as pos, count(*) over (partition by source_file) as n_rows from flows),
l as (select source_file, label, count(*) as n, min(pos) / any_value(greatest(n_rows - 1, 1)) as min_pos, quantile_cont(pos, 0.5) / any_value(greatest(n_rows - 1, 1)) as median_pos, max(pos) / any_value(greatest(n_rows - 1, 1)) as max_pos from p group by all),
s as (select * from (values {", ".join(f"('{x}', {k})" for k, x in enumerate(_SUBLABELS))}) t(label, seq))
select source_file, l.label, n, round(min_pos, 8) as min_pos, round(median_pos, 8) as median_pos, round(max_pos, 8) as max_pos, lag(l.label) over o as previous, coalesce(lag(seq) over o > seq, false) as violates
from l join s on l.label = s.label window o as (partition by source_file order by median_pos, l.label)""",
)
def _(spark, d):
    """Raw sub-labels against their schedule, as fractions of the whole files' lengths, before anything is cleaned."""
    f = flows(spark, d).select("row_id", "source_file", "row_index", normalize_raw_label(F.col("label_raw")).alias("label"))
    placed = captures.positions_by_order(f, "source_file", "row_index")
    lengths = f.groupBy("source_file").agg(F.count("*").alias("n_rows"))
    schedule = spark.createDataFrame([(f"cap_{k}", x, i) for k in range(8) for i, x in enumerate(_SUBLABELS)], "source_file string, label string, seq int")
    order = S.observed_order(S.label_positions(placed, "source_file", "label", "position", lengths), schedule, "source_file", "label")
    return order.select("source_file", "label", "n", *[F.round(c, 8).alias(c) for c in ("min_pos", "median_pos", "max_pos")], "previous", "violates")


@query("schedule_absences", f"with {CLEAN}, s as (select * from (values ('BENIGN'),('DoS'),('PortScan'),('Bot')) t(label)), f as (select 'cap_' || k as source_file from range(9) t(k)) select source_file, label from f, s where not exists (select 1 from clean c where c.source_file = f.source_file and c.label = s.label)")
def _(spark, d):
    """Labels of the published schedule that a capture lacks: one class never occurs, one capture doesn't exist."""
    rows = [(f"cap_{k}", x) for k in range(9) for x in ("BENIGN", "DoS", "PortScan", "Bot")]
    return S.schedule_absences(clean(spark, d), spark.createDataFrame(rows, "source_file string, label string"), "source_file", "label")


@query("split_overlap", f"with {SPLIT} select count(*) as overlap from (select row_id from split where side = 'train' intersect select row_id from split where side = 'test')")
def _(spark, d):
    s = split(spark, d)
    return s.where("side = 'train'").select("row_id").intersect(s.where("side = 'test'").select("row_id")).agg(F.count("*").alias("overlap"))


@query("class_union", f"with {SPLIT} select label from split where side = 'train' union select label from split where side = 'test'")
def _(spark, d):
    s = split(spark, d)
    return s.where("side = 'train'").select("label").union(s.where("side = 'test'").select("label")).distinct()


@query("stratified_subsample", f"with {CLEAN}, {_ordered('label', 42)}, q as (select *, least(n, greatest(20, round_even(1000.0::double * n / count(*) over (), 0)::bigint)) as quota from r) select row_id, label from q where rn <= quota")
def _(spark, d):
    return S.stratified_subsample(clean(spark, d), "label", "row_id", 1000, 20).select("row_id", "label")


@query("stratified_split", f"with {CLEAN}, {_ordered('label', 42)} select row_id, label, case when rn <= least(n - 1, round_even(n * 0.3::double, 0)::bigint) then 'test' else 'train' end as side from r")
def _(spark, d):
    return S.split_random(clean(spark, d), "label", "row_id").select("row_id", "label", "side")


@query("split_min_test", f"with {CLEAN}, {_ordered('label', 42)} select row_id, label, case when rn <= least(n - 1, greatest(50, round_even(n * 0.3::double, 0)::bigint)) then 'test' else 'train' end as side from r")
def _(spark, d):
    return S.split_random(clean(spark, d), "label", "row_id", min_test=50).select("row_id", "label", "side")


def nested_sql(table_: str, label: str, row: str, size: str, least: int, seed: str, out: str = "", after: str = "") -> str:
    return f"""c as (select {label} as label, count(*) as n from {table_} group by 1),
q0 as (select label, n, greatest(least({least}, n), least(floor({size} * n / sum(n) over ())::bigint, n)) as q, row_number() over (order by n desc, label) = 1 as big from c),
q as (select label, case when big then {size} - (sum(q) over () - q) else q end as quota from q0),
r as (select t.*, row_number() over (partition by {label} order by md5(concat_ws(':', '{seed}', {label}, {row}::varchar)), {row}) as rn from {table_} t)
select {out.replace("label", f"r.{label}", 1) or f"{row}, {label}"} from r join q on r.{label} = q.label where rn <= quota{after.replace("label", f"r.{label}")}"""


@query("nested_sample", "with k as (select count(*) // 4 as k from orders), " + nested_sql("orders", "o_orderpriority", "o_orderkey", "(select k from k)", 50, "42"))
def _(spark, d):
    o = table(spark, d, "orders")
    return S.nested_sample(o, "o_orderpriority", "o_orderkey", o.count() // 4, 50).select("o_orderkey", "o_orderpriority")


@query("independent_sample", "with " + nested_sql("orders", "o_orderpriority", "o_orderkey", "1000", 10, str(42 * 1_000_003 + 1000)))
def _(spark, d):
    return S.independent_sample(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 1000, 10).select("o_orderkey", "o_orderpriority")


def _bulk_sql(size: int, whole: int) -> str:
    return f"""with {CLEAN}, {_ordered('label', 42)}, c as (select label, count(*) as n from clean group by label),
s as (select coalesce(sum(n) filter (where n <= {whole}), 0)::bigint as small, coalesce(sum(n) filter (where n > {whole}), 0)::bigint as bulk, sum(n)::bigint as every from c),
q as (select label, case when n <= {whole} or every <= {size} then n else least(n, greatest(1, round_even(greatest(0, {size} - small)::double * n / bulk, 0)::bigint)) end as quota from c, s)
select row_id, r.label from r join q using (label) where rn <= quota"""


@query("search_subset", _bulk_sql(2000, 200))
def _(spark, d):
    return S.search_subset(clean(spark, d), "label", "row_id", 2000, 200).select("row_id", "label")


@query("search_subset_bulk", _bulk_sql(4000, 1000))
def _(spark, d):
    return S.search_subset(clean(spark, d), "label", "row_id", 4000, 1000).select("row_id", "label")


@query("composite_subsample", _bulk_sql(3000, 500))
def _(spark, d):
    return S.search_subset(clean(spark, d), "label", "row_id", 3000, 500).select("row_id", "label")


@query("stratified_folds", f"with {CLEAN}, {_ordered('label', 42)}, k as (select greatest(2, least(5, min(n))) as k from r) select row_id, label, ((rn - 1) % k)::int as fold from r, k")
def _(spark, d):
    return S.stratified_folds(clean(spark, d), "label", "row_id", 5).select("row_id", "label", "fold")


@query("rare_aware_folds", f"with {CLEAN}, {_ordered('label', 42)} select row_id, label, case when n >= 60 then ((rn - 1) % 60)::int end as fold from r")
def _(spark, d):
    """60 folds, so that rare classes are pinned on small data too."""
    return S.stratified_folds(clean(spark, d), "label", "row_id", 60, pin_rare=True).select("row_id", "label", "fold")


@query("group_folds", f"with {CLEAN}, c as (select source_file, count(*) as n from clean group by 1), f as (select source_file, ((row_number() over (order by n desc, source_file) - 1) % 3)::int as fold from c) select source_file, fold, count(*) as n from clean join f using (source_file) group by all")
def _(spark, d):
    return S.group_folds(clean(spark, d), "source_file", 3).groupBy("source_file", "fold").agg(F.count("*").alias("n"))


@query("source_holdout", f"with {CLEAN}, tr as (select * from clean where source_file not in ('cap_6','cap_7')), {_ordered('label', 42, 'tr')} select row_id, label, 'train' as side from r where label <> 'BENIGN' or rn <= 500 union all select row_id, label, 'test' from clean where source_file in ('cap_6','cap_7')")
def _(spark, d):
    c = clean(spark, d)
    held = F.col("source_file").isin("cap_6", "cap_7")
    train = S.capped_classes(c.where(~held), "label", "row_id", 500, ["BENIGN"]).select("row_id", "label", F.lit("train").alias("side"))
    return train.union(c.where(held).select("row_id", "label", F.lit("test")))


@query("shuffle_labels", f"with {CLEAN}, a as (select row_id, row_number() over (order by md5(concat_ws(':', '42', 'all', row_id::varchar)), row_id) as rn from clean), b as (select label, row_number() over (order by md5(concat_ws(':', '43', 'all', row_id::varchar)), row_id) as rn from clean) select row_id, label from a join b using (rn)")
def _(spark, d):
    return S.shuffle_labels(clean(spark, d).select("row_id", "label"), "label", "row_id").select("row_id", "label")


@query("balanced_cap", f"with {CLEAN}, {_ordered('label', 42)}, k as (select floor(1000 / count(distinct label)) as k from clean) select row_id, label from r, k where rn <= k")
def _(spark, d):
    return S.balanced_cap(clean(spark, d), "label", "row_id", 1000).select("row_id", "label")
