"""Shared plumbing: scratch tables that survive lost executors, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow (a few bytes a row) table is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 400_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where it is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if conf.get("spark.master", "").startswith("local["):
        own = spark.conf.get("spark.flowmill.scratch", "")
        if not own:
            own = tempfile.mkdtemp(prefix="flowmill-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.conf.set("spark.flowmill.scratch", own)
        return own
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_flowmill_scratch"


def materialize(df: DataFrame, name: str, done: list[str] | None = None) -> DataFrame:
    """Write df to a new table of the shared folder and read it again (cuts the lineage). Its path is
    added to `done`, for discard() once nothing reads the table any more."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/flowmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if done is not None:
        done.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, done: list[str]) -> None:
    """Delete tables of materialize()."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while done:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done.pop())
        path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint only if it has at most `limit` rows. df must be narrow and cheap
    to count (a materialised table); beyond the limit the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until none is a column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def columns_of(df: DataFrame) -> list:
    """df's columns by name, odd characters included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
