"""Flow and prediction views over the driver's tables, and the same views as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LABEL = """case when event_type='view' then ' BENIGN'
  when event_type='click' then case event_id % 4 when 0 then 'DoS Hulk' when 1 then 'dos  slowloris'
        when 2 then 'DoS GoldenEye' else 'DoS attacks-Hulk' end
  when event_type='error' then concat('Web Attack ', {c}(150), case when event_id % 2 = 0 then ' XSS' else ' Brute Force' end)
  when event_type='purchase' then case when event_id % 2 = 0 then 'FTP-Patator ' else 'SSH-Bruteforce' end
  else case when event_id % 400 < 4 then 'Heartbleed' when event_id % 50 = 7 then 'Label'
        when event_id % 50 = 9 then 'Mystery' when event_id % 3 = 0 then 'Infilteration' else 'Bot' end end"""

_TRUTH = "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty labelled flows from events: odd spacing and control characters in labels, repeated
    headers, unknown labels, infinite and missing rates, a constant column."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as row_id", "event_id as row_index", "ts", "cast(ts as date) as capture_day",
        "concat('cap_', cast(user_id % 8 as string)) as source_file", _LABEL.format(c="char") + " as label_raw",
        "case when event_id % 97 = 0 then double('Infinity') when event_id % 101 = 0 then double('NaN') else value end as f_rate",
        "value as f_value", "cast(user_id as double) as f_user", "cast(get_json_object(props,'$.k') as double) as f_k", "cast(1 as double) as f_const",
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rule-made models' predictions over five classes, with a score for class 2."""
    models = spark.createDataFrame([(m,) for m in range(4)], "model int")  # four rows
    truth = table(spark, sf_dir, "events").selectExpr("event_id as row_id", f"{_TRUTH} as y_true")
    return truth.join(F.broadcast(models)).selectExpr(
        "row_id", "model", "y_true",
        "cast(case when (row_id * (model + 3)) % 17 < model + 1 then (y_true + 1 + model) % 5 else y_true end as int) as y_pred",
        "((row_id * 7919) % 1000) / 2000.0D + case when y_true = 2 then 0.4D else 0.0D end as score",
    )


FLOWS = f"""flows as (select event_id as row_id, event_id as row_index, ts, cast(ts as date) as capture_day,
 concat('cap_', cast(user_id % 8 as varchar)) as source_file, {_LABEL.format(c="chr")} as label_raw,
 case when event_id % 97 = 0 then 'Infinity'::double when event_id % 101 = 0 then 'NaN'::double else value end as f_rate,
 value as f_value, cast(user_id as double) as f_user, cast(json_extract_string(props,'$.k') as double) as f_k, cast(1 as double) as f_const
from events)"""

PREDS = f"""preds as (select e.row_id, m.model, e.y_true,
 cast(case when (e.row_id * (m.model + 3)) % 17 < m.model + 1 then (e.y_true + 1 + m.model) % 5 else e.y_true end as int) as y_pred,
 ((e.row_id * 7919) % 1000) / 2000.0::double + case when e.y_true = 2 then 0.4::double else 0.0::double end as score
from (select event_id as row_id, {_TRUTH} as y_true from events) e cross join (values (0),(1),(2),(3)) m(model))"""

#: The label families of the combined normaliser, as SQL over an expression for the cleaned key.
KEY = "lower(trim(regexp_replace(regexp_replace({0}, '[^\\x20-\\x7E]', ' ', 'g'), ' +', ' ', 'g')))"
FAMILY = """case when k in ('benign','normal') then 'BENIGN'
 when k in ('dos hulk','dos goldeneye','dos slowloris','dos slowhttptest') or starts_with(k,'dos attacks-') then 'DoS'
 when starts_with(k,'ddos') then 'DDoS' when k = 'portscan' then 'PortScan' when k = 'bot' then 'Bot'
 when starts_with(k,'web attack') or k in ('brute force -web','brute force -xss','sql injection') then 'Web Attack'
 when k in ('ftp-patator','ssh-patator','ftp-bruteforce','ssh-bruteforce') or starts_with(k,'brute force') then 'Brute Force'
 when k in ('infiltration','infilteration') then 'Infiltration' when k = 'heartbleed' then 'Heartbleed' else 'Other' end"""

LABELED = f"{FLOWS}, labeled as (select *, {FAMILY} as label from (select *, {KEY.format('label_raw')} as k from flows))"
CLEAN = f"""{LABELED}, clean as (select row_id, row_index, ts, capture_day, source_file, label, f_rate::float as f_rate, f_value::float as f_value,
 f_user::float as f_user, f_k::float as f_k, f_const::float as f_const from labeled
 where trim(label_raw) <> 'Label' and label <> 'Other' and isfinite(f_rate) and isfinite(f_value) and isfinite(f_user) and isfinite(f_k))"""
