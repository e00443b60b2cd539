"""Tables in the shared folder that cut a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark sends to a Python worker at a time while a table is written.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, one of
    its own in local mode; on a cluster nobody else would see that, so there the setting is needed."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Appends ``df`` to the table at ``path``. Python workers get batches of bounded size, however long the rows are."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.mode("append").parquet(path)
    finally:
        conf.set(_BATCH, before)
    _written[path] = df.sparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table: what comes after neither repeats nor loses what came before."""
    path = scratch(df.sparkSession)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def numbered(df: DataFrame, name: str, *order: str | Column, first: int = 0) -> DataFrame:
    """``df`` as a table with a column ``name`` that numbers its rows from ``first`` in an order, without gaps. Rows are sorted
    over all tasks; only the number of rows of each partition, a row a partition, is counted ahead."""
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = {}, first
    for p, n in sizes:
        starts[p], at = at, at + n
    before = df.sparkSession.createDataFrame(list(starts.items()), "_p long, _before long")
    out = rows.join(F.broadcast(before), part == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_at", "_p", "_before")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`cut` that nothing reads any more, such as those of a loop's earlier rounds."""
    for df in tables:
        path = getattr(df, "_table", None)
        if path is not None and (spark := _written.pop(path, None)) is not None:
            _delete(spark, path)


@atexit.register
def _clear() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return
