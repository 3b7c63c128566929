"""Deterministic sampling and splitting.

Rows of a stratum are ordered by md5(seed:stratum:row id): the order doesn't depend on partitioning and
a longer prefix contains every shorter one. Ranks are computed without gathering a stratum: rows
fall into buckets by the leading digits of their hash, bucket totals are prefix-summed (a bounded
number of rows a stratum) and only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, same_groups

#: Leading hexadecimal digits that name a bucket: 4,096 buckets a stratum.
BUCKET_DIGITS = 3


def sample_key(seed: int, stratum: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), stratum.cast("string"), row_id.cast("string")))


def hash_rank(df: DataFrame, stratum: str, row_id: str, seed: int = 42, out: str = "rn") -> DataFrame:
    """df with the 1-based rank of each row in its stratum's fixed random order, and the stratum's
    size `n`."""
    keyed = df.withColumn("_key", sample_key(seed, F.col(stratum), F.col(row_id))).withColumn("_b", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = keyed.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_bb")).agg(F.count("*").alias("_c"))
    by_bucket = Window.partitionBy("_s").orderBy("_bb")
    buckets = buckets.withColumns({"_ahead": F.coalesce(F.sum("_c").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy("_s"))}).drop("_c")
    inside = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_key", row_id))
    ranked = keyed.withColumn("_in", inside).join(buckets, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")))
    return ranked.withColumn(out, F.col("_ahead") + F.col("_in")).drop("_key", "_b", "_s", "_bb", "_ahead", "_in")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def _whole(counts: DataFrame) -> DataFrame:
    """counts with the total over all classes (one row a class)."""
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))


def take_quota(df: DataFrame, quotas: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """The first `quota` rows of each class in its fixed order."""
    ranked = hash_rank(df, label, row_id, seed).drop("n")
    q = quotas.select(F.col("label").alias("_l"), "quota")
    return ranked.join(q, F.col(label) == F.col("_l")).where("rn <= quota").drop("_l", "quota", "rn")


def proportional_quota(counts: DataFrame, size: int, min_per_class: int = 1) -> DataFrame:
    """max(min_per_class, round-half-even(size * n / total)), at most n."""
    q = F.greatest(F.lit(min_per_class), F.bround(F.lit(float(size)) * F.col("n") / F.col("total")).cast("long"))
    return _whole(counts).select("label", "n", F.least(q, F.col("n")).alias("quota"))


def nested_quota(counts: DataFrame, size: int, min_per_class: int) -> DataFrame:
    """Quotas that grow with `size` class by class and sum to it exactly: floors of the proportions,
    at least the class minimum; the largest class takes the balance, and an impossible balance
    is an error."""
    least = F.least(F.lit(min_per_class), F.col("n"))
    share = F.floor(F.lit(size) * F.col("n") / F.col("total")).cast("long")
    q = _whole(counts).withColumn("_q", F.greatest(least, F.least(share, F.col("n"))))
    biggest = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "label")) == 1
    balance = F.lit(size) - (F.sum("_q").over(Window.partitionBy()) - F.col("_q"))
    q = q.withColumns({"_big": biggest, "_bal": balance})
    bad = F.col("_big") & ((F.col("_bal") < least) | (F.col("_bal") > F.col("n")))
    quota = F.when(bad, F.raise_error(F.lit("the sample size can't be met with this class minimum")).cast("long")).when(F.col("_big"), F.col("_bal")).otherwise(F.col("_q"))
    return q.select("label", "n", quota.alias("quota"))


def nested_sample(df: DataFrame, label: str, row_id: str, size: int, min_per_class: int = 0, seed: int = 42) -> DataFrame:
    return take_quota(df, nested_quota(class_counts(df, label), size, min_per_class), label, row_id, seed)


def independent_sample(df: DataFrame, label: str, row_id: str, size: int, min_per_class: int = 0, seed: int = 42) -> DataFrame:
    """As nested_sample, but each size draws its own order."""
    return nested_sample(df, label, row_id, size, min_per_class, seed * 1_000_003 + size)


def stratified_subsample(df: DataFrame, label: str, row_id: str, size: int, min_per_class: int = 1, seed: int = 42) -> DataFrame:
    return take_quota(df, proportional_quota(class_counts(df, label), size, min_per_class), label, row_id, seed)


def bulk_quota(counts: DataFrame, size: int, whole_up_to: int) -> DataFrame:
    """Classes of at most whole_up_to rows whole; the others share the rest of the budget by size."""
    small = F.col("n") <= whole_up_to
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))).over(Window.partitionBy()), F.lit(0))
    budget = F.greatest(F.lit(0), F.lit(size) - sums(small))
    share = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(budget.cast("double") * F.col("n") / sums(~small)).cast("long")))
    fits = F.sum("n").over(Window.partitionBy()) <= size
    return counts.select("label", "n", F.when(small | fits, F.col("n")).otherwise(share).alias("quota"))


def search_subset(df: DataFrame, label: str, row_id: str, size: int, whole_up_to: int, seed: int = 42) -> DataFrame:
    return take_quota(df, bulk_quota(class_counts(df, label), size, whole_up_to), label, row_id, seed)


def split_random(df: DataFrame, label: str, row_id: str, test_size: float = 0.3, min_test: int = 0, seed: int = 42) -> DataFrame:
    """df with `side`: of each class round(n * test_size) rows, at least min_test, test; one row
    always trains."""
    ranked = hash_rank(df, label, row_id, seed)
    n_test = F.least(F.greatest(F.lit(min_test), F.bround(F.col("n") * F.lit(test_size)).cast("long")), F.col("n") - 1)
    return ranked.withColumn("side", F.when(F.col("rn") <= n_test, "test").otherwise("train")).drop("rn", "n")


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int, seed: int = 42, pin_rare: bool = False) -> DataFrame:
    """df with `fold`; the number of folds is clipped to the smallest class (at least 2), or classes
    smaller than it are pinned to training (null fold)."""
    ranked = hash_rank(df, label, row_id, seed)
    if pin_rare:
        return ranked.withColumn("fold", F.when(F.col("n") >= folds, (F.col("rn") - 1) % folds).cast("int")).drop("rn", "n")
    least = class_counts(df, label).agg(F.greatest(F.lit(2), F.least(F.lit(folds), F.min("n"))).alias("_k"))
    return ranked.join(F.broadcast(least)).withColumn("fold", ((F.col("rn") - 1) % F.col("_k")).cast("int")).drop("rn", "n", "_k")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """df with `fold`: whole groups, dealt out from the largest to the smallest."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.orderBy(F.desc("_n"), "_g")) - 1  # one row a group
    return df.join(sizes.withColumn("fold", (place % folds).cast("int")).drop("_n"), F.col(group) == F.col("_g")).drop("_g")


def capped_classes(df: DataFrame, label: str, row_id: str, cap: int, classes: list[str] | None = None, seed: int = 42) -> DataFrame:
    """At most `cap` rows of each class (or of the listed ones)."""
    ranked = hash_rank(df, label, row_id, seed)
    over = F.col("rn") > cap
    return ranked.where(~(over & F.col(label).isin(*classes)) if classes else ~over).drop("rn", "n")


def balanced_cap(df: DataFrame, label: str, row_id: str, budget: int, seed: int = 42) -> DataFrame:
    """At most budget // number of classes rows of each class."""
    n = class_counts(df, label).agg(F.floor(F.lit(budget) / F.count("*")).alias("_cap"))
    return hash_rank(df, label, row_id, seed).join(F.broadcast(n)).where("rn <= _cap").drop("rn", "n", "_cap")


def shuffle_labels(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Labels permuted against rows: the i-th row of one random order gets the label of the i-th of another."""
    base = df.withColumn("_all", F.lit("all"))
    one = hash_rank(base.drop(label), "_all", row_id, seed).drop("n", "_all")
    two = hash_rank(base.select("_all", row_id, label), "_all", row_id, seed + 1).select("rn", label)
    return one.join(two, "rn").drop("rn")


#: Rows of a group that one task ranks.
RANGE_ROWS = 1_000_000


def chronological_rank(df: DataFrame, groups: list[str], order: str, tie: str, buckets: int = 200, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the 1-based `rank` of each row in its group by order and tie, and the group's size
    `n`. Groups are counted first: up to range_rows rows a group, they are ranked in one shuffle. Else a
    group may hold most rows: `order` (a number, date or timestamp) is cut into approximate
    quantile ranges, the ranges' totals are prefix-summed and rows are ranked within a range. Null
    groups are groups; null orders come first."""
    largest = df.groupBy(*groups).agg(F.count("*").alias("_c")).agg(F.max("_c")).first()[0] or 0
    if largest <= range_rows:
        own = Window.partitionBy(*groups)
        return df.withColumns({"rank": F.row_number().over(own.orderBy(order, tie)), "n": F.count(F.lit(1)).over(own)})
    keys = [f"_g{i}" for i in range(len(groups))]
    when = dict(df.dtypes)[order] in ("date", "timestamp", "timestamp_ntz")
    value = F.col(order).cast("timestamp").cast("double") if when else F.col(order).cast("double")

    def beside(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)] + [F.col(m) == F.col(f"{m}k") for m in more]
        return left.join(right, reduce(lambda a, b: a & b, same)).drop(*keys, *[f"{m}k" for m in more])

    named = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)]
    edges = df.groupBy(*named).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 1000).alias("_e"))
    at = F.when(value.isNull(), 0).otherwise(F.size(F.filter("_e", lambda e: e < value)))
    ranged = beside(df, edges).withColumn("_r", at).drop("_e")
    counts = ranged.groupBy(*named, F.col("_r").alias("_rk")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"_ahead": F.coalesce(F.sum("_c").over(w.orderBy("_rk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(w)}).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy(order, tie))
    placed = beside(ranged.withColumn("_in", inside), counts, "_r")
    return placed.withColumns({"rank": F.col("_ahead") + F.col("_in"), "n": F.col("_n")}).drop("_r", "_in", "_ahead", "_n")


def chronological_split(df: DataFrame, groups: list[str], order: str, tie: str, test_size: float = 0.3, buckets: int = 200, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with `side`: the first max(1, min(n-1, floor(n * (1 - test_size)))) rows of each group by
    chronological_rank() train, the rest test; a single row trains."""
    cut = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(1.0 - test_size))))
    side = F.when((F.col("n") == 1) | (F.col("rank") <= cut), "train").otherwise("test")
    return chronological_rank(df, groups, order, tie, buckets, range_rows).withColumn("side", side).drop("rank", "n")


def dataset_fingerprint(df: DataFrame, label: str) -> DataFrame:
    """(fingerprint, n_rows, n_columns): SHA-256 of the shape, the columns in order and the class counts."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))  # a row a class
    entry = F.struct("label", F.concat_ws("=", "label", F.col("n").cast("string")).alias("e"))
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ";")
    total = F.coalesce(F.sum("n"), F.lit(0))
    text = F.concat(total.cast("string"), F.lit(f"x{len(df.columns)};{','.join(df.columns)};"), labels)
    return c.agg(F.sha2(text, 256).alias("fingerprint"), total.alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def split_manifest(split: DataFrame, label: str) -> DataFrame:
    """(label, n_train, n_test) of every class."""
    return split.groupBy(F.col(label).alias("label")).agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"))


def require_test_rows(split: DataFrame, label: str, least: int) -> DataFrame:
    """Classes present in test with fewer than `least` rows there."""
    return split_manifest(split, label).where((F.col("n_test") > 0) & (F.col("n_test") < least)).select("label", "n_test")


def require_split(split: DataFrame, label: str, least: int = 0) -> DataFrame:
    """split, or an error if a side is empty or a class of the test side has fewer than `least` rows there."""
    counts = split_manifest(split, label).collect()  # a row a class
    for side in ("train", "test"):
        if not sum(r[f"n_{side}"] for r in counts):
            raise ValueError(f"the split's {side} side is empty")
    if short := {r["label"]: r["n_test"] for r in counts if 0 < r["n_test"] < least}:
        raise ValueError(f"classes with fewer than {least} test rows: {short}")
    return split


def manifest_mismatches(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Classes whose train or test counts differ from the declared ones (absent counts are 0)."""
    a = actual.select("label", F.col("n_train").alias("_at"), F.col("n_test").alias("_ae"))
    d = declared.select("label", F.col("n_train").alias("_dt"), F.col("n_test").alias("_de"))
    j = a.join(d, "label", "full_outer").na.fill(0)
    return j.where("_at <> _dt or _ae <> _de").select("label", F.col("_at").alias("actual_train"), F.col("_dt").alias("declared_train"), F.col("_ae").alias("actual_test"), F.col("_de").alias("declared_test"))


def label_positions(df: DataFrame, source: str, label: str, order: str, lengths: DataFrame | None = None) -> DataFrame:
    """Where each label sits in its source, as fractions of the source's length: its largest order or,
    for 0-based row positions, the last row of a file of `n_rows` by lengths (source, n_rows)."""
    if lengths is None:
        ends = df.groupBy(source).agg(F.greatest(F.max(order), F.lit(1)).alias("_d"))
    else:
        ends = lengths.select(source, F.greatest(F.col("n_rows") - 1, F.lit(1)).alias("_d"))
    stats = df.groupBy(source, label).agg(F.count("*").alias("n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    mid = quantiles(df, [order], [0.5], [source, label]).select(F.col(source).alias("_s"), F.col(label).alias("_l"), F.col("q")[0].alias("_mid"))
    j = stats.join(ends, source).join(mid, same_groups([source, label], ["_s", "_l"]))
    return j.select(source, label, "n", *[(F.col(a) / F.col("_d")).alias(b) for a, b in (("_lo", "min_pos"), ("_mid", "median_pos"), ("_hi", "max_pos"))])


def schedule_absences(positions: DataFrame, schedule: DataFrame, source: str, label: str) -> DataFrame:
    """(source, label) of the schedule, a small table, that have no row in the captures."""
    here = positions.select(source, label).distinct()
    return schedule.select(source, label).join(here, [source, label], "left_anti")


def observed_order(positions: DataFrame, schedule: DataFrame, source: str, label: str) -> DataFrame:
    """positions of the scheduled labels with `seq`, the label whose median comes right before
    (`previous`) and `violates`: the schedule puts that one later. schedule: (source, label, seq), a small
    published table."""
    w = Window.partitionBy(source).orderBy("median_pos", label)  # a row a scheduled label
    j = positions.join(schedule, [source, label])
    return j.withColumns({"previous": F.lag(label).over(w), "violates": F.coalesce(F.lag("seq").over(w) > F.col("seq"), F.lit(False))})


def chronology_violations(positions: DataFrame, schedule: DataFrame, source: str, label: str) -> DataFrame:
    """Pairs next to each other in observed median order whose scheduled order (seq) is the reverse."""
    found = observed_order(positions, schedule, source, label).where("violates")
    return found.select(source, F.col("previous").alias("left_label"), F.col(label).alias("right_label"))


def require_chronology(positions: DataFrame, schedule: DataFrame, source: str, label: str) -> DataFrame:
    """positions, or an error that names scheduled labels without a row, else pairs that contradict the schedule."""
    if absent := schedule_absences(positions, schedule, source, label).orderBy(source, label).limit(100).collect():
        raise ValueError("scheduled labels absent from their captures: " + ", ".join(f"{r[0]}: {r[1]}" for r in absent))
    if wrong := chronology_violations(positions, schedule, source, label).orderBy(source, "left_label").limit(100).collect():
        raise ValueError("row order contradicts the schedule: " + ", ".join(f"{r[0]}: {r[1]} before {r[2]}" for r in wrong))
    return positions
